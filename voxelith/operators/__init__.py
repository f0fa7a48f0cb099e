"""voxelith.operators"""
