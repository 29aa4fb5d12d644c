"""taxoloom: corpus analytics and taxonomy induction on Spark."""
