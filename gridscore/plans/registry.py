"""All queries of the library but the training-data ones, each with its SQL where SQL can express it."""

from gridscore.plans import q_imports, q_scores, q_spans, q_text

_ALL = {**q_scores.ENTRIES, **q_text.ENTRIES, **q_imports.ENTRIES, **q_spans.ENTRIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
