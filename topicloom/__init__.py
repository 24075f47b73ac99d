"""Topic trends over large text collections, as composable Spark DataFrame functions."""
