"""vantloom.sources"""
