"""Training-data operators over the documents and pages tables.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
