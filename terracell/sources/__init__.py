"""File formats as tables: raster grids, GeoTIFF, Shapefile and LAS.

Files are read through Spark's binary reader, one task a file, so they may lie wherever Spark can read.
A raster is written as a folder of tiles, files that stand by themselves, by the executors through
``pyarrow.fs``; a tile is written under another name first and then moved, so a task that is run again does
no harm.  Formats are described by their published specifications.
"""

from . import geotiff, grids, las, shapefile, tools  # noqa: F401
