"""Rows and word splitting shared by the tests of this folder."""
import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_mod = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_mod)
odd_rows, words, PASSAGE, LONG = _mod.odd_rows, _mod.words, _mod.PASSAGE, _mod.LONG
