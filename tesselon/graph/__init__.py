"""Graphs as vertex and edge tables."""
