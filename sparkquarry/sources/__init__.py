"""sparkquarry.sources"""
