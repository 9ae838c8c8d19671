"""sparkquarry.operators"""
