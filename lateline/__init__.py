"""Transit-delay analytics as Spark jobs: dataset building, feature stages, models, quality checks."""
