"""Training-data operators at corpus scale.

One module per operator; ``queries.py`` binds each one to its whole table.
Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
