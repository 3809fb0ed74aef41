"""All registered queries of the engine."""

from tallyloom.plans import causes, comparisons, diffs, files, further, more, nesting, patches, runs, scalars, sequences, state, texts  # noqa: F401
from tallyloom.plans.registry import ORACLES, QUERIES  # noqa: F401
