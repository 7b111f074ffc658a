"""Readers and writers: image folders, raster tables, detection tables, run logs."""
