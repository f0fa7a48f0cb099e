"""voxelith.sources"""
