"""skein: assembly-graph analytics and corpus preparation on Spark."""
