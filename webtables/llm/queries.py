"""All registered queries of the subpackage: name -> (Spark query, DuckDB SQL or None)."""

from webtables.llm import bpe, conversations, decontaminate, exact_dedup, line_dedup, neighbours, phrases, quality, secrets, sharding, simhash, token_files, toxicity

QUERIES = {name: query for module in (simhash, sharding, toxicity, secrets, decontaminate, bpe, token_files, line_dedup, exact_dedup, quality, neighbours, conversations, phrases) for name, query in module.QUERIES.items()}
