"""The queries of this subpackage and their SQL."""

from annalist.llm import chat, clusters, decontaminate, jaccard, langid, lm, mixing, substrings, suffixes, toxicity, vectors, warc, whitening

_MODULES = (langid, jaccard, toxicity, warc, decontaminate, substrings, vectors, chat, mixing, lm, clusters, suffixes, whitening)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
