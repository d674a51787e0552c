"""metascrub: Spark jobs that find and remove identity-bearing metadata in large file collections."""
