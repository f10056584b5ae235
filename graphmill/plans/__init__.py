"""graphmill.plans"""
