from halyard.plans.engine import main

main()
