from crossmer.cli import main

main()
