"""Registered queries: each names the operator it stands for and carries its oracle SQL."""
