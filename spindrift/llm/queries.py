"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from spindrift.llm import bpe, contamination, language, licences, lines, quality, simhash, substrings, tiff, token_files

MODULES = (token_files, simhash, tiff, lines, quality, substrings, language, licences, bpe, contamination)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
