"""vantloom.streaming"""
