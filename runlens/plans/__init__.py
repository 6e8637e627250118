"""Tabular inputs of a study: sampling plans, scenario grids, event schedules."""
