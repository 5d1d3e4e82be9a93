"""Operators for building training text out of many videos' transcripts.

A *transcript* is one row per video: ``vid`` (bigint) and ``text``, the video's lines joined
by line ends. Nothing outside this subpackage imports it.
"""
