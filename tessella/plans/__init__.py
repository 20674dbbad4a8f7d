"""tessella.plans"""
