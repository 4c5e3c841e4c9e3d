"""vantloom.functions"""
