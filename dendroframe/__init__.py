"""Spark-first analytics of 3-D point clouds of trees and their cylinder models."""
