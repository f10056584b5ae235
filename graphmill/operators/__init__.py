"""graphmill.operators"""
