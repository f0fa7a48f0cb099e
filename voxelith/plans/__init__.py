"""voxelith.plans"""
