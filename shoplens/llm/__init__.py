"""Training-data operators: language ID, de-duplication, decontamination,
chat formatting, tokenisation and token files.

Nothing else in the library imports this package; its queries are registered
by ``queries.py`` and added by ``__spark_entry__.py`` when it is installed.
"""
