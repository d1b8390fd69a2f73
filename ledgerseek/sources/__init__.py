"""Bindings of tables to the ledger model, and the shard store."""
