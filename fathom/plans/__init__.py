"""fathom.plans"""
