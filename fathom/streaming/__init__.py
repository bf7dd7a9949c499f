"""fathom.streaming"""
