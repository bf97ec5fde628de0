"""Operators for preparing training text: scoring, extraction, rules, dedup, tokens, scans."""
