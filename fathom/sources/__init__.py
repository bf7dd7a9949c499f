"""fathom.sources"""
