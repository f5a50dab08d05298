"""Operators over tables of pages, words, jobs and events."""
