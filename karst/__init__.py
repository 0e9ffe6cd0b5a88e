"""karst: a PySpark-native principal-component and genotype analytics engine."""
