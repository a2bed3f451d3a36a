"""All registered queries by name, and the SQL that states their results."""

from __future__ import annotations

from . import annotations, calibrated, curation, genome, geometry, models, mutations, panels, resampled, spectral, statistics, storage, stores, structured, summaries

MODULES = (geometry, calibrated, statistics, mutations, curation, stores, panels, summaries, models, genome, resampled, spectral, storage, structured, annotations)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
