"""Graph queries, replay, retention, validation and writes over a lineage log."""
