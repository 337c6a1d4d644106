"""Operators over listings: filtering, ranking, matching, retrieval, maintenance."""
