"""voxelith: Spark-native 3D tiling and point-cloud analytics."""

__version__ = "0.1.0"
