"""Where rows come from and where they go: tables, record logs, sinks."""
