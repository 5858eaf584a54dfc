"""What SQL texts of the engine mean where Spark reads them otherwise."""
