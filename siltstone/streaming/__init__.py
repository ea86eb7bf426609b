"""Profiles and checks over unbounded tables."""
