"""Training-data operators: ten corpus operations at Spark scale.

Nothing outside this folder imports it.  Queries and oracle SQL live in
:mod:`ledgerseek.llm.queries`.
"""
