"""graphmill.functions"""
