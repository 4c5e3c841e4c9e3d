"""vantloom.plans"""
