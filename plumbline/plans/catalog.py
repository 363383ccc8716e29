"""Imports every module that registers queries."""

from . import REGISTRY, fix_queries, generate_queries, geo_queries, kernel_queries, map_queries, package_queries, raster_queries, stream_queries, track_queries, warp_queries, window_queries

__all__ = ["REGISTRY", "fix_queries", "generate_queries", "geo_queries", "kernel_queries", "map_queries", "package_queries", "raster_queries", "stream_queries", "track_queries", "warp_queries", "window_queries"]
