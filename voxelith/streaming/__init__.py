"""voxelith.streaming"""
