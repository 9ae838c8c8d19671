"""sparkquarry.plans"""
