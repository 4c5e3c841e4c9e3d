"""vantloom.operators"""
