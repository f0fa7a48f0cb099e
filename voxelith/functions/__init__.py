"""voxelith.functions"""
