"""All registered queries of the library, by name, with their SQL."""

from plume.jobs import fields, grids, meshes, models, seeds, series, stores, tracks, weathering

QUERIES = {**fields.QUERIES, **tracks.QUERIES, **grids.QUERIES, **weathering.QUERIES, **stores.QUERIES, **series.QUERIES, **seeds.QUERIES, **meshes.QUERIES, **models.QUERIES}
ORACLE = {**fields.ORACLE, **tracks.ORACLE, **grids.ORACLE, **weathering.ORACLE, **stores.ORACLE, **series.ORACLE, **seeds.ORACLE, **meshes.ORACLE, **models.ORACLE}
