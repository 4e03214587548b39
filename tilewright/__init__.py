"""tilewright: Spark jobs over map data (tiles, scenes, paths, features, events)."""
