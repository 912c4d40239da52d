"""Operators on DataFrames of objects, pairs, ranks, trees and clusters."""
