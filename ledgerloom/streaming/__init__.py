"""Uploads that arrive one file at a time."""
