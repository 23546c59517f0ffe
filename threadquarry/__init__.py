"""Set-at-a-time PySpark operators for mining needs from threaded comments."""
