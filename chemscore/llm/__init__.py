"""Training-data operators (decontamination, deduplication, tokens, filters).

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` depends on it.
"""
