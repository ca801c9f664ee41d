"""DataFrame -> DataFrame steps built from the expressions in ``functions``."""
