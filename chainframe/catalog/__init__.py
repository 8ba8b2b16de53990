"""Every registered query with its SQL counterpart."""

from . import dataset, evaluation, flows, language, sourcing, workload

MODULES = [language, workload, evaluation, dataset, sourcing, flows]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: s for m in MODULES for name, s in m.ORACLES.items()}
