"""graphmill.streaming"""
