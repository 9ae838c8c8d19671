"""sparkquarry.functions"""
