"""Corpus jobs: the steps that turn raw text into training data.

Nothing outside this package imports it; `queries` lists what it registers.
"""
