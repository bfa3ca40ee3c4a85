"""Operators on counts, graphs and proportions."""

from mixspark.operators.features import informative_genes, leverage, normalise, select_hvg, select_markers
from mixspark.operators.graph import adjacency, auto_lambda, degrees, grid_graph, knn_graph, laplacian, radius_graph
from mixspark.operators.metrics import correlation, evaluate, jsd, mae, rare_detection, rmse
from mixspark.operators.sketch import countsketch, project, rademacher
from mixspark.operators.solver import objective, proportions, solve

__all__ = [
    "adjacency", "auto_lambda", "correlation", "countsketch", "degrees", "evaluate", "grid_graph", "informative_genes", "jsd", "knn_graph", "laplacian", "leverage", "mae",
    "normalise", "objective", "project", "proportions", "rademacher", "radius_graph", "rare_detection", "rmse", "select_hvg", "select_markers", "solve",
]
