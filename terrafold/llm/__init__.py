"""Training-data operators (quality, dedup, URL, WARC, secrets, licences, toxicity, BPE, language, decontamination).

Nothing outside this subpackage imports it; ``registry`` lists its queries and their SQL.
"""
