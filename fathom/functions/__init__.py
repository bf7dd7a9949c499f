"""fathom.functions"""
