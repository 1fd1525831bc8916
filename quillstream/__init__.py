"""quillstream: a Spark-native engine for web metadata and text corpora.

Tables of pages, responses, URLs or documents go in; tables of ranked
metadata, provenance, decisions and cleaned fields come out. Everything is a
DataFrame-to-DataFrame function; nothing is fetched and nothing is collected.
"""
