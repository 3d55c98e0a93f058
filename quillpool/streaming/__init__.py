"""The engine is a batch engine: no operator here needs a stream."""
