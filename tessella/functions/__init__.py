"""tessella.functions"""
