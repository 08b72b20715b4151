"""tutorloom: study analytics and corpus topic discovery as PySpark DataFrame operators."""
