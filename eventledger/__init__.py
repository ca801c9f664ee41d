"""Order-event processing on Spark: ingest, keyed log, idempotent persistence,
dead letters and replay, paged reads, and the measurements that go with them."""
