"""Training-data operators: ten corpus operators and their registered queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
