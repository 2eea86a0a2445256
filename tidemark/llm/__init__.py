"""Training-data operators: language, media, lines, tokens, packing, vectors, copies, pages, privacy.

Nothing outside this package imports it.  Each operator lives in its own module and
keeps a general interface; :mod:`tidemark.llm.queries` derives the driver's queries.
"""
