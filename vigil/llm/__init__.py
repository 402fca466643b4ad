"""Training-data operators (language ID, quality, secrets, sharding, dedup,
HTML extraction, toxicity, tokenising, decontamination, near-dedup).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
