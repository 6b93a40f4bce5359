"""The similarity join of ``operators/vertical.py`` over the five-word runs of plain forms."""

from __future__ import annotations

from functools import partial

from corpusloom.llm.shingles import batch_runs
from corpusloom.operators import vertical
from corpusloom.operators.vertical import _ENTRY, SHORT_BYTES, _mur, _routes, even_keys, fragment_keys  # noqa: F401

_entries = partial(vertical._entries, runs_of=batch_runs)
similar_texts = partial(vertical.similar_texts, runs_of=batch_runs)
