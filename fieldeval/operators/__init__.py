"""DataFrame operators: alignment with truth, rates, accuracy, rankings and run reports."""
