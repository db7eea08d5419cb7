"""newsprism: article-collection analytics as Spark jobs."""
