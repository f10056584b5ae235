"""graphmill.sources"""
