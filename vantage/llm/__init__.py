"""Training-data operators and the corpus pipeline; nothing else in the library imports this package.

``QUERIES`` and ``ORACLES`` are filled by the operator modules (one ``opN_<name>`` each) and by
``corpus_pipeline.py`` at the repository top.
"""
