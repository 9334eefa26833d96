"""geoskein: vector geometry and polygon skeletons as Spark DataFrame operators."""
