"""Training-data operators for corpora: dedup, tokens, language, licences, packing,
secrets, media columns, BPE, toxicity and nearest neighbours.

Nothing outside this subpackage imports it; ``queries.register()`` hands its queries to
the entry module.
"""
